"""Helpers shared by the training-data operators: word patterns, folds, settled tables, bounded samples.

Conventions that hold for every operator here:

* an operator first selects the columns it needs, so extra or clashing columns of its input never matter;
* one row comes out for each row that came in, repeated rows included, unless its docstring says otherwise;
* a null text is an empty text; a null doc_id hashes as the empty string.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Python and for Java: a run of characters other than blank, tab, line feed, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
words_of = WORD.findall

#: For `rows` of map_columns: whole Arrow batches.
WHOLE = 1 << 30

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else, as bytes.lower does."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def remainder(doc_id: Column, modulus: int = 5) -> Column:
    """crc32 of doc_id as text, modulo `modulus`; a null id counts as the empty string."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir, or else by setCheckpointDir. Where neither is set, a temporary
    one on a local master; on a cluster that is an error, as executors don't share the driver's folders."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = folder.get() if folder.isDefined() else getattr(spark, "_clustrum_tmp", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = spark._clustrum_tmp = tempfile.mkdtemp(prefix="clustrum-")
    return named.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared checkpoint folder and read it back: lineage ends there, and a lost executor
    costs nothing that was settled before. The shuffle files of the write go with its end, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/settled-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_settled_path", None)
        if path:
            jvm = df.sparkSession._jvm
            jpath = jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a long column that names each row, and that column's name: its doc_id if ids are neither null nor
    repeated, else a number that a settled copy of the table fixes."""
    name = "row"
    while name in docs.columns:
        name += "_"
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if not ids.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    return settled(docs.withColumn(name, F.monotonically_increasing_id())), name


def sampled(df: DataFrame, key: Column, total: int, bound: int) -> DataFrame:
    """Rows of `df` chosen by a hash of `key` so that about `bound` of its `total` rows stay (all of them if they are fewer)."""
    if total <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < F.lit(int(bound / total * (1 << 30))))


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts are large rows: where the session leaves the number of rows in an Arrow batch open, set it to 1000 instead
    of Spark's 10000, which buffers on both sides of each Python worker hold several times. A number that the session
    sets, 10000 included, stays."""
    if spark.conf.get(BATCH_ROWS, None) is None:
        spark.conf.set(BATCH_ROWS, "1000")


def map_columns(df: DataFrame, work, schema: str, rows: int = 2048) -> DataFrame:
    """Run `work(*columns)` (lists in, a list of output columns out) over `df`, at most `rows` rows of an Arrow batch
    at a time, so that a task holds few rows as Python objects. Work that sums up its rows takes more of them."""
    small_batches(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        arrow = _arrow_schema(target)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = work(*[c.to_pylist() for c in batch.slice(at, rows).columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(struct):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duckdb_crc32(text: str) -> str:
    """crc32 of a VARCHAR of ASCII characters in DuckDB, byte by byte over a table made by rule."""
    entries = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        entries.append(i)
    return f"xor(list_reduce([ascii(c)::BIGINT FOR c IN string_split({text}, '')], lambda acc, b: xor(acc >> 8, ({entries}::BIGINT[])[(xor(acc, b) & 255) + 1]), 4294967295), 4294967295)"
