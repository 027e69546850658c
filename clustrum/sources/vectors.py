"""Dense and sparse vector sources as (id, x): x an ARRAY<DOUBLE> or a MAP<BIGINT, DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import numbered

def _in_order(rows: DataFrame, x: Column) -> DataFrame:
    """(id, x): ids 0, 1, ... in the order of the files' names and of the lines in them."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")]
    return numbered(rows.select(*place, x.alias("x")), within_file=False).select(F.col("line").alias("id"), "x")



def dense(df: DataFrame, id_column: str, *columns: str) -> DataFrame:
    """From one array column, or from several numeric ones."""
    x = F.col(columns[0]).cast("array<double>") if len(columns) == 1 and dict(df.dtypes)[columns[0]].startswith("array") else F.array(*[F.col(c).cast("double") for c in columns])
    return df.select(F.col(id_column).cast("long").alias("id"), x.alias("x"))


def sparse(df: DataFrame, id_column: str, indices: str, values: str) -> DataFrame:
    """From parallel arrays of indices and values; unequal lengths are an error of the row."""
    lengths = F.size(indices) == F.size(values)
    x = F.when(lengths, F.map_from_arrays(F.col(indices).cast("array<bigint>"), F.col(values).cast("array<double>")))
    checked = F.when(lengths, x).otherwise(F.raise_error(F.concat(F.lit("indices and values differ in length for id "), F.col(id_column).cast("string"))))
    return df.select(F.col(id_column).cast("long").alias("id"), checked.alias("x"))


def sparse_long(df: DataFrame, id_column: Column, index: Column, value: Column) -> DataFrame:
    """From long form, one row an entry; repeated entries add up."""
    sums = df.groupBy(id_column.cast("long").alias("id"), index.cast("long").alias("i")).agg(F.sum(value.cast("double")).alias("v"))
    return sums.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("i", "v")))).alias("x"))


def read_table(spark: SparkSession, path: str, header: bool = True, skip: int = 1, sep: str = ",") -> DataFrame:
    """(id, x) of a delimited file without its first `skip` columns; `?` and blanks are 0. Ids are places of
    the rows, from 0."""
    raw = spark.read.csv(path, header=header, sep=sep, nullValue="?")
    x = F.array(*[F.coalesce(F.expr(f"try_cast(`{c}` AS double)"), F.lit(0.0)) for c in raw.columns[skip:]])
    return _in_order(raw, x)


def read_indexed(spark: SparkSession, path: str) -> DataFrame:
    """(id, x) of lines `[label] i:v i:v ...`; ids are places of the lines that are not blank, from 0."""
    entries = F.filter(F.split(F.trim("value"), r"\s+"), lambda e: e.contains(":"))
    pairs = F.transform(entries, lambda e: F.struct(F.split(e, ":")[0].cast("bigint").alias("key"), F.split(e, ":")[1].cast("double").alias("value")))
    return _in_order(spark.read.text(path).where(F.trim("value") != ""), F.map_from_entries(pairs))


def projected(samples: DataFrame, dimensions: int, seed: int = 0) -> DataFrame:
    """Gaussian random projection of dense samples to `dimensions`."""
    import numpy as np

    n = samples.select(F.size("x").alias("n")).first()["n"]
    axes = np.random.default_rng(seed).normal(size=(dimensions, n)) / dimensions**0.5
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in a]) for a in axes])
    dot = lambda a: F.aggregate(F.zip_with("x", a, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return samples.select("id", F.transform(rows, dot).alias("x"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(id, x) of an image file of big-endian header (magic, count, rows, columns) and one byte a pixel."""
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    raw = spark.read.format("binaryFile").load(path).select("content", number(5).alias("n"), (number(9) * number(13)).alias("size"))
    image = raw.select("size", "content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("id"))
    pixels = image.select(F.col("id").cast("long"), "size", F.substring(F.col("content"), 17 + F.col("id") * F.col("size"), F.col("size")).alias("p"))
    return pixels.select("id", F.transform(F.sequence(F.lit(1), "size"), lambda j: F.conv(F.hex(F.substring(F.col("p"), j, F.lit(1))), 16, 10).cast("double")).alias("x"))


def concatenated(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, x): the vectors of equal ids, one behind the other."""
    return left.join(right.select("id", F.col("x").alias("y")), "id").select("id", F.concat("x", "y").alias("x"))


def scaled(samples: DataFrame, *factors: float) -> DataFrame:
    """(id, x): each dimension times its factor."""
    by = F.array(*[F.lit(float(f)) for f in factors])
    return samples.select("id", F.zip_with("x", by, lambda v, f: v * f).alias("x"))
