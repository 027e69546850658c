"""Session defaults and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "clustrum", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; `conf` keys may use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    own = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"} | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=own).getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder of spark.checkpoint.dir and read it back, so that rounds of a loop neither
    recompute earlier ones nor depend on an executor's memory."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # nothing reads the shuffle files of this write again
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
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or of setCheckpointDir; a temporary one on a local master, an error else."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = folder.get() if folder.isDefined() else getattr(spark, "_clustrum_rounds", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = spark._clustrum_rounds = tempfile.mkdtemp(prefix="clustrum-")
    return named.rstrip("/")
